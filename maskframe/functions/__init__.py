"""maskframe.functions"""
