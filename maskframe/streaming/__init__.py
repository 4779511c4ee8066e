"""maskframe.streaming"""
