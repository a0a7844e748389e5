"""Tables, overlays of unmerged changes, and result sinks."""
