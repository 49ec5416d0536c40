"""slabwise.sources"""
