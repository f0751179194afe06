"""The registered queries, by subject, each beside the SQL that gives the same rows."""
