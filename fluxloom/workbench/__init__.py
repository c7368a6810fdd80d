"""The library's operators as queries over the driver tables, with SQL to check them."""
