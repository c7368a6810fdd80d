"""Random-forest estimation of flux parameters on MLlib."""
