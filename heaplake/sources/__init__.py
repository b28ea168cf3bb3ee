"""Sources and sinks: the binary dump format and materialised tables."""
