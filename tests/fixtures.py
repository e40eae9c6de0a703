"""Two small export files of one service day.

Six trips: late, early, exactly five minutes late, a stored status that
contradicts the delay, an empty trip, and one past midnight; a line with a
leading zero.  Five tickets: two of one trip, a free one validated before its
trip, and one of an unknown trip.  The expected values in test_golden.py were
worked out by hand.
"""

TRIP_CSV = """trip_id,service_date,line,direction,vehicle_no,driver_id,start_time,end_time,planned_start,planned_end,delay_min,km,boardings,occupancy_pct,energy_kwh,status,productive,trip_type
11,2025-11-03,040,Hin,W-11,D1,06:00:00,06:41:00,06:00:00,06:29:00,12,10.5,20,40.0,30.25,verspätet,true,1
12,2025-11-03,040,Rück,W-12,D2,07:00:00,07:27:00,07:00:00,07:30:00,-3,10.5,30,50.0,20.00,planmäßig,true,1
13,2025-11-03,7,Hin,W-13,D3,08:00:00,08:35:00,08:00:00,08:30:00,5,22.25,41,75.5,44.50,verspätet,false,2
14,2025-11-03,7,Rück,W-13,D3,09:00:00,09:34:00,09:00:00,09:30:00,4,22.25,9,12.5,40.25,verspätet,true,1
15,2025-11-03,88,Hin,W-14,D4,10:00:00,10:20:00,10:00:00,10:20:00,0,8.0,0,0.0,11.00,planmäßig,true,1
16,2025-11-03,88,Hin,W-14,D5,23:50:00,00:16:00,23:50:00,00:10:00,6,8.0,17,33.0,12.00,verspätet,true,1
"""

TICKET_CSV = """trip_id,validated_at,fare_type,amount_eur,payment_method,stop
11,2025-11-03 06:10:00,Einzel,3.20,Bar,Markt
11,2025-11-03 06:12:30,Tages,8.10,Handy,Bahnhof
12,2025-11-03 06:58:00,Abo,0.00,eTicket,Markt
13,2025-11-03 08:01:00,Einzel,3.20,Karte,Hafen
99,2025-11-03 08:05:00,Einzel,3.20,Bar,Hafen
"""


def write(tmp_path, name: str, text: str) -> str:
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)
