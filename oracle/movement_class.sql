SELECT * FROM movements
