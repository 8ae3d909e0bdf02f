SELECT * FROM hour_value
