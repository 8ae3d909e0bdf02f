SELECT * FROM value_per_unit
