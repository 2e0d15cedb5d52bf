"""Civic-records analytics on Spark: meetings, votes, speech, attendance, matters, search and the data work beneath them."""
