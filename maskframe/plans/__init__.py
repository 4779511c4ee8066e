"""maskframe.plans"""
