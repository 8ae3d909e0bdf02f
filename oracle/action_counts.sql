SELECT * FROM day_actions
