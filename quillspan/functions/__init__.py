"""Part of quillspan."""
