"""axisloom.streaming"""
