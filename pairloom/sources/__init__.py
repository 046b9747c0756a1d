"""Sources: directory listings, and relations made of the test tables."""
