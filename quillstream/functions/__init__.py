"""Part of the quillstream library."""
