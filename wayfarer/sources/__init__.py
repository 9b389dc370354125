"""File sources and sinks; ``files`` has them all."""
