"""strideflow.sources"""
