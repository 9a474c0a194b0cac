"""No operator here is a streaming one: every input is a finite, ordered table of a song or a file.

The stateless column functions and the readers' parsers work on streaming DataFrames as they are.
"""
