SELECT * FROM responses
