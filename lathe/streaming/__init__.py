"""lathe.streaming"""
