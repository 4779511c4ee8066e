"""maskframe.sources"""
