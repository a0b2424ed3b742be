"""Jobs that users run: a function that takes a session, a command line and a config file each."""
