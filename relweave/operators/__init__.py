"""Operators over sparse relations, graphs, vectors and rankings."""
