"""Plan shapes written by hand where Catalyst does not derive them."""
