"""Incremental forms: conversion of arriving files and running scores."""
