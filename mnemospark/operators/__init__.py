"""mnemospark operators."""
