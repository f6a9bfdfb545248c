"""Raw sensor frames: containers and pixel codecs."""
