"""Plan-level helpers: join rewrites, frontier loops, and the phase runner."""
