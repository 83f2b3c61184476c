"""lathe.sources"""
