"""The fixtures of the folder above serve here too."""
