"""DataFrame -> DataFrame operators.

Every text operator overwrites one text column and adds its counters.  A pattern is
first tested with one `rlike`; counting, splitting and decoding run only on rows that
hit, so a clean row pays one scan per step.  No operator in the text path shuffles.
"""
