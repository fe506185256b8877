"""axisloom.plans"""
