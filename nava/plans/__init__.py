"""nava.plans"""
