"""nava.operators"""
