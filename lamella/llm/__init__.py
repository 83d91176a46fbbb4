"""Operators of a training-data pipeline over document tables; nothing else imports them."""
