"""maskframe.operators"""
