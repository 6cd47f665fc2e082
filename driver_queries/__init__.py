"""The library's operators bound to the shared test tables, with SQL to check them."""
