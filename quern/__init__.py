"""quern: warehouse analytics, a guarded SQL gateway, schema linking and evaluation on PySpark."""
