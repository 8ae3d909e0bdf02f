SELECT * FROM day_bands
