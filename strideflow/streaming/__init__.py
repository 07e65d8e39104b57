"""strideflow.streaming"""
