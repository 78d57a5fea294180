"""Part of the aksharaflow library."""
