"""lathe.functions"""
