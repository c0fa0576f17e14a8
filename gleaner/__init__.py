"""Content analytics on Spark: inboxes of links, pages, notes, comment threads and transcripts as DataFrames."""
