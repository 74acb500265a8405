"""Tables the jobs start from and the log they write."""
