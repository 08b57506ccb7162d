"""Column helpers: geometry, grids, clocks, transport modes, classes."""
