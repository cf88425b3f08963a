"""Part of loquat."""
