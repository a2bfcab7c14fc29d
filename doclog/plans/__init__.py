"""The fixture log and the registered queries."""
