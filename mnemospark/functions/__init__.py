"""mnemospark functions."""
