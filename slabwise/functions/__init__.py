"""slabwise.functions"""
