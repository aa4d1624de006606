"""Tables, views, files and codecs."""
