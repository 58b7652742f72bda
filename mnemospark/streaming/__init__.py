"""mnemospark streaming."""
