"""Operators over decoded relations: snapshots, catalogues, statistics and selection."""
