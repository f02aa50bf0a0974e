"""Training-data operators over the ``documents`` table; nothing outside this subpackage imports it."""
