class FormatError(ValueError):
    """The bytes are not a cell file or manifest that can be read."""
