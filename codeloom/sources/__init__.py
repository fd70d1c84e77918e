"""Tables and files read and written."""
