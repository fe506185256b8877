"""axisloom.functions"""
