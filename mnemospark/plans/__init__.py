"""mnemospark plans."""
