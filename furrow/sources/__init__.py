"""Sources: stored tables, relations derived from the driver's tables, and station readings over HTTP."""
