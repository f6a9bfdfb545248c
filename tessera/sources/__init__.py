"""Scans and sinks: record decoders, stream framing, capture bundles and text snapshots."""
