"""axisloom.sources"""
