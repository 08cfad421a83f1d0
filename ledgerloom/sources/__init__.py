"""Tables, statement files and sinks."""
