"""nava.sources"""
