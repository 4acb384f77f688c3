"""An extension: files that arrive over time join the translation cache once each."""
