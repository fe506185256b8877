"""axisloom.operators"""
