"""strideflow.queries"""
