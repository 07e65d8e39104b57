"""strideflow.operators"""
