"""A library of functions from DataFrames to DataFrames for a catalogue of fabrics, styles and posts."""
