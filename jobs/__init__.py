"""Jobs that run the library over given tables; each has a command line, a function that takes a session, and a configuration file."""
