"""Where data comes from and goes to: archives, records, stations, listing pages, table versions."""
