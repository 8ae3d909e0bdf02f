SELECT * FROM class_shares
