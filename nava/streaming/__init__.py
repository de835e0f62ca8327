"""nava.streaming"""
