"""Set-based operators; each takes the network and a table of requests."""
