"""nava.functions"""
