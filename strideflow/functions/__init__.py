"""strideflow.functions"""
