"""pixelloom: images as pixel relations, and the steps of raw development and document scanning as DataFrame operators."""
