"""lathe.operators"""
