"""Runnable jobs: a command line and a config file each, the work in a function that takes a session."""
