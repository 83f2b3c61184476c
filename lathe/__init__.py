"""lathe: engineering-document analytics on Spark."""
