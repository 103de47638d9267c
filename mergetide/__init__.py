"""Software-delivery analytics as Spark jobs.

Raw pull-request pages are ingested (batch or stream), shredded strictly into
typed rows and turned into delivery metrics with DataFrame operators that also
work on any other table.
"""
